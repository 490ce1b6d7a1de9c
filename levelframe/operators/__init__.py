"""DataFrame operators: raster, fitting, candidates, temporal state, evaluation."""
