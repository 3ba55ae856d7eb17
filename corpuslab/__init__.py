"""corpuslab: curating, scoring and evaluating parallel text corpora on Spark."""
