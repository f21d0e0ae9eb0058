"""fragmill: similarity search over tandem mass spectra, expressed as Spark DataFrame plans."""
