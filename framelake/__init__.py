"""framelake: a PySpark-native analytics engine for annotated moving-image data."""
