"""loomtone: loop-library catalogs as Spark DataFrame operators."""
