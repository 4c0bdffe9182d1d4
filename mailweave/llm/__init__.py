"""Operators for training data made from mail and documents."""
