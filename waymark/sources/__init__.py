"""Tables that are read and written: master, coordinates, log."""
