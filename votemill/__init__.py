"""votemill: label-agreement analytics and change-history processing on PySpark."""
