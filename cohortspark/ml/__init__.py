"""Feature stages, classifiers, model selection and explanations on ``pyspark.ml``."""
