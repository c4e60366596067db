"""Ways in and out: ticks, raw bar files, the panel store and the logs."""
