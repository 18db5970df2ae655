"""Writers and exporters."""
