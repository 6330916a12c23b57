"""Reading and writing modalities."""
