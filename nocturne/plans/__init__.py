"""Planning on the driver: the channel-expression language."""
