"""Text analytics on Spark: spelling, grammar, morphology, script conversion and lexicons as DataFrame operators."""
