"""A PySpark-native analytics engine for payment-ledger data and for training-data pipelines."""
