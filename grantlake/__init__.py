"""A PySpark-native engine for catalogues of semi-structured public-benefit records."""
