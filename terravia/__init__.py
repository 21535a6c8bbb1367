"""terravia: a PySpark-native analytics engine for recorded journeys, terrain and text corpora."""
