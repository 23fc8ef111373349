"""The row-wise operators over streams."""
