"""Sources: table readers, the binding of the driver tables to the observation
model, payload normalisation and raster / polygon readers."""
