"""gaugeworks: PySpark-native analytics for tool-description quality data."""
