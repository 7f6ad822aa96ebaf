"""Streaming: requests arriving as files are answered micro-batch by micro-batch (see ``ledger_stream``)."""
