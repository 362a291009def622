"""Dataset transforms: each takes a DataFrame and options and returns a DataFrame.

Where a result depends on row order, the order is the column ``ORDER`` (see ``with_order``); partition
order is never relied on."""
