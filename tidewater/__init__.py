"""tidewater: cohort analytics over event, text and prediction tables, written as Spark DataFrame plans."""
