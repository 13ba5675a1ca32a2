"""Readers: the sequential scan of one member's text into fact rows. Each runs on one member in a Python worker; all that relates members is done on the rows."""
