"""DataFrame operators: matching, history, maintenance, packing, graphs, rendering."""
