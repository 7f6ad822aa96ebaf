"""Plans: sinks and staged runs that write between steps."""
