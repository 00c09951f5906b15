"""Pure Python and numpy algorithms; nothing here imports Spark."""
