"""Whole stages composed from the operators: features, back-test, scenario run, reports."""
