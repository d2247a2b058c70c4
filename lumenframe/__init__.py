"""Image-detection analytics and corpus preparation as plain DataFrame transformations."""
