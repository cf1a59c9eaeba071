"""corploom: preparation and measurement of language-model corpora on Spark."""
