"""Study presets and end-to-end plans."""
