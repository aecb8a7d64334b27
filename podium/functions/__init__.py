"""Part of the chart analytics library."""
