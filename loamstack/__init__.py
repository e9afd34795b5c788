"""loamstack: a PySpark-native engine that turns raw administrative documents and web pages into a searchable corpus."""
