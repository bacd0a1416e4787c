"""orefield: data-mining operators as plain DataFrame -> DataFrame functions on Spark."""
