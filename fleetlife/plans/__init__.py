"""Multi-step analyses: survival curves, regressions, evaluation, explanation, imputation, scoring."""
