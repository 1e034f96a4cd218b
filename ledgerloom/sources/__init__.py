"""Readers and the views of the driver tables that feed the operators."""
