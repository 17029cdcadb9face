"""DataFrame -> DataFrame operators. All are lazy unless they fit a model."""
