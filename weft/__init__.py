"""weft: curation and analysis of training corpora as Spark DataFrame plans."""
