"""Credit-risk analytics on Spark: DataFrame operators for profiling, features,
sampling, model evaluation, scoring, outcome labelling and monitoring."""

__version__ = "0.1.0"
