"""weftline: a Spark-native engine for code graphs, activity logs, experiments and corpora."""
