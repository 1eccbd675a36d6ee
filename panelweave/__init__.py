"""panelweave: a PySpark-native engine for cross-sectional panels and the data preparation around them."""
