"""A Spark-native engine that matches requirement texts against a catalogue and audits the outcome."""
