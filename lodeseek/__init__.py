"""Evidence retrieval over source and text corpora on Spark: chunks, lexical and vector rankings, fusion, reranking, answers."""
