"""Building blocks that keep large joins, ranks and running sums distributed."""
