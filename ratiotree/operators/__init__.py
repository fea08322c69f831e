"""Relational operators around the model: preparation, histograms, splits, trees, boosting, reports, resampling, reserving."""
