"""See the package docstring for how the modules are laid out."""
