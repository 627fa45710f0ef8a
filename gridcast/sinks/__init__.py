"""Writers. Every table is written by the executors; only one-row reports are formatted as text."""
