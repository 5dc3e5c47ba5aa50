"""lodestone: a PySpark-native engine for building, searching and measuring a knowledge base."""
