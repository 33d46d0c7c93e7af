"""Tables, files and the shipping of the package."""
