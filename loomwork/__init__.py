"""loomwork: curation, de-duplication, sampling and evaluation of labelled, embedding-backed datasets on Spark."""
