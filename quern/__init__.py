"""A PySpark engine for preparing, mixing and evaluating multimodal training data."""
