"""PySpark-native analytics for automotive CAN and CAN-FD bus logs."""
