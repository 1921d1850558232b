"""Offer analytics as Spark jobs: extraction, merging, matching and reporting of bank and wallet offers."""
