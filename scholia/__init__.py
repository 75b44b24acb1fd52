"""Scholia: Spark jobs for learning content, learner analytics and training data."""
