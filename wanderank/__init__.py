"""wanderank: personalized PageRank over large multigraphs, declared as Spark plans."""
