"""Pipelines that chain the operators: raw to processed, processed to features, features to model."""
