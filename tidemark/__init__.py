"""Analytics over periodic full snapshots of a catalogue, written for PySpark."""
