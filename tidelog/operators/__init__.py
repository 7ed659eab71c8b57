"""DataFrame-to-DataFrame operators: folds, joins, rankings, suppression rules, audits."""
