"""Sources: the driver's parquet tables, premises, resumed events, and the fixture views built from them."""
