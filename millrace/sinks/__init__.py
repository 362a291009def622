"""Results as texts: SVG of marks, HTML of pages."""
