"""Random walks over large static directed graphs, declared as Spark plans."""
