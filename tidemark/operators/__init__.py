"""Indicator operators: staged window expressions and ordered folds."""
