"""taxon: DataFrame operators for labelling catalogue items at scale."""
