"""The end-to-end jobs: window report, feature table, analysis, evaluation."""
