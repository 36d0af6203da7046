"""DataFrame → DataFrame operators (profile, clean, quality, metrics,
insights, questions, formulas, verification, exploration)."""
