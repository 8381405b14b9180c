"""voxmart: customer-voice analytics expressed as PySpark DataFrame operators."""
