"""Distributional incidence of a carbon price, as Spark DataFrame operators."""
