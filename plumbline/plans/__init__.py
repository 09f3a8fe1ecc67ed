"""Plans: usage context, dimension indicators, scoring, preparation recipes."""
