"""lexiloom: text-originality analytics as Spark DataFrame plans."""
