"""Privacy-policy and control analytics as Spark DataFrame operators."""
