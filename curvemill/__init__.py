"""Light-curve analytics as Spark jobs: clean, detrend, search, vet, classify, rank."""
