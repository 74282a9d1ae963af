"""Operators over DataFrames: segmentation, splitting, scaling, adaptation, features, classifiers, metrics, statistics."""
