"""Behavioural event, log, sensor and trace analytics as plain DataFrame functions."""
