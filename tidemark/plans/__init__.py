"""Plans over many series: alignment joins, cross-sections, evaluation of trades."""
