"""A Spark-native code index: relations of source code and full-text queries over them."""
