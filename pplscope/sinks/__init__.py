"""Writers with declared schemas."""
