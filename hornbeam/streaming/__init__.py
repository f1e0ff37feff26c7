"""Programs over streams of facts."""
