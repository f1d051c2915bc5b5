"""Reading and writing tables, score partitions and exchange files."""
