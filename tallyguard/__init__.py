"""Spark-native audit of database schemas, migrations, configuration and text columns."""
