"""pulsewarden: Spark-native surveillance of large panels of daily count series."""
