"""A PySpark-native engine for AI-answer visibility analytics and training-data operators."""
