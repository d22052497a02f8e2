"""Where facts come from and where they are kept."""
