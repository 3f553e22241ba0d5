"""Code-fact analytics on Spark: typed fact tables, a catalogue of questions over them, and
scale-out operators for skewed keys, hierarchies, nested records and dangling references."""
