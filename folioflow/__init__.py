"""folioflow: a PySpark-native engine that turns books and pages into typed paragraphs, chapters, clips and timelines."""
